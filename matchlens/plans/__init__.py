"""matchlens.plans"""
