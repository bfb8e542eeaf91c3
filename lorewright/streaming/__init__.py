"""lorewright.streaming"""
