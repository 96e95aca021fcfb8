"""Training-data operators: one module per operator, thin ``opN_*`` queries in :mod:`.queries`.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and returns a
DataFrame; extra columns of the input are ignored, so clashing names cannot break an operator.
"""
