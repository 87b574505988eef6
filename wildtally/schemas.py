"""Schemas of the tables read and written.

Partition columns are declared as strings: left to inference, ``m=02`` would turn into the
integer 2 and ``u0=06`` into 6 while ``u1=1e`` stayed text.
"""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


_S, _D, _L = StringType(), DoubleType(), LongType()

SELECTOR_PARTITION = ["u0", "u1", "u2", "uuid"]
DAY_PARTITION = ["y", "m", "d"]

OCCURRENCE = _table(
    ("taxon", _S), ("lat", _D), ("lng", _D), ("start", _L), ("id", _S), ("added", _L), ("source", _S)
)
CHECKLIST = _table(("taxonPath", _S), ("recordCount", _L))
# Where the records of a selector are: a load, how many of its records, and the first and last day-time among them.
LOADS = ArrayType(_table(("load", _S), ("n", _L), ("first", _L), ("last", _L)))
SUMMARY = _table(
    ("itemCount", _L), ("status", _S), ("taxonSelector", _S), ("wktString", _S), ("traitSelector", _S), ("loads", LOADS)
)
MONITORED = _table(("occurrenceId", _S), ("monitorUUID", _S))
LOADED_OCCURRENCE = _table(*[(f.name, f.dataType) for f in OCCURRENCE], ("uuid", _S))
LOADED_MONITORED = _table(("occurrenceId", _S), ("monitorUUID", _S), ("added", _L))
SELECTOR = _table(("taxonSelector", _S), ("wktString", _S), ("traitSelector", _S))
TRAIT = _table(("taxon", _S), ("trait", _S), ("value", _D))


def with_partitions(schema, names):
    return StructType(schema.fields + [StructField(name, _S, True) for name in names])
