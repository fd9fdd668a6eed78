"""matchlens.streaming"""
