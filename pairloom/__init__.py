"""pairloom: a PySpark engine that curates datasets of pairwise protein complexes.

Every operator takes DataFrames and returns DataFrames. Parquet is the form between
stages; TSV and FASTA exist only at the edges.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the functions themselves and so needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
