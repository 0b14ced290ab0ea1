"""pairloom: parallel-text corpora as Spark tables.

The package works on one record, the sentence pair (see ``schema.PAIR``), and on
explicit positions: every ordered table carries an ``ord`` (position inside its
language pair) or ``pos`` (position in the combined stream) column, because Spark
rows have no order of their own.
"""
