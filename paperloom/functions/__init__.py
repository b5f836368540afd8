"""paperloom.functions"""
