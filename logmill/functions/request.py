"""Parts of the request text, ``<method> <endpoint> <protocol>``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST_PARTS = ["request_type", "api", "protocol"]


def request_parts(request: Column) -> list[Column]:
    """Method, endpoint and protocol; NULL where missing, extra words ignored."""
    words = F.split(request, " ")
    return [F.get(words, F.lit(i)).alias(name) for i, name in enumerate(REQUEST_PARTS)]
