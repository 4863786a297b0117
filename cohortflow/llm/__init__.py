"""Operators for large-scale training-data pipelines (chat formatting to packing).  Nothing outside imports this."""
