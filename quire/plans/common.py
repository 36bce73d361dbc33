from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame) -> DataFrame:
    """Widen small integer columns to bigint (the oracle engine's integer type)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
