"""corpusflow.functions"""
