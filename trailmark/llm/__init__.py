"""Training-data operators (numbered one to ten) and their registered queries."""
