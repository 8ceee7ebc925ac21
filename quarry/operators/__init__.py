"""Operators over records, entities and graphs: DataFrame in, DataFrame out."""
