"""lumenframe.streaming"""
