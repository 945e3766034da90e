"""linkloom: link-graph and text-corpus analytics on PySpark."""
