"""lorewright.operators"""
