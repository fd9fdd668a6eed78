"""matchlens.sources"""
