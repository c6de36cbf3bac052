"""strandlog.functions"""
