"""strandlog.streaming"""
