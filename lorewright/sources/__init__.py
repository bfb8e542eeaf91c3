"""lorewright.sources"""
