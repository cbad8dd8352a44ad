"""Training-data operators: text, pages and conversations at corpus scale.

Nothing else in the library imports this subpackage.
"""
