"""corpusflow.streaming"""
