"""matchlens.operators"""
