"""Training-data operators: ten corpus-preparation operators and their registered queries.

Nothing else in the library imports this subpackage.
"""
