"""skein: a knowledge-graph analytics engine expressed in PySpark DataFrames."""
