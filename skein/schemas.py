"""Row schemas of the graph. ``seq`` is the insertion order where "first" or "last" decides."""

from pyspark.sql import types as T

EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
MODALITIES = ("code", "document", "pdf", "image", "video", "concept")

_TYPES = {"seq": T.LongType(), "pos": T.IntegerType(), "weight": T.DoubleType(), "metadata": T.MapType(T.StringType(), T.StringType())}


def _schema(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(n, T.StringType())) for n in names.split()])


NODES = _schema("id label modality source_file source_location metadata seq")
EDGES = _schema("source target relation confidence source_file source_location context weight seq")
#: One tagged row for everything that a file gives; split by ``kind`` afterwards.
FACTS = _schema("kind rel_path pos id label modality source_location metadata source target relation confidence context name line")
