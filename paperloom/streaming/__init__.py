"""paperloom.streaming"""
