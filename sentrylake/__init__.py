"""sentrylake: feature engineering, labelling and block decisions over network event tables.

Every public function takes a DataFrame (plus parameters) and returns a DataFrame or a
Column.  Nothing is collected on the driver except one-row statistics.
"""

__version__ = "0.1.0"
