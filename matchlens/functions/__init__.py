"""matchlens.functions"""
