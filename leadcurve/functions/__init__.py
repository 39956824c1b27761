"""SQL expressions.

Every function takes SQL expression text (a column name is the usual case)
and returns SQL expression text, for ``F.expr`` and ``selectExpr``. Wide
lists of expressions are much cheaper to hand to Catalyst as text than as
trees built call by call.
"""
