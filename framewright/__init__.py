"""framewright: Spark-native preparation and scoring of paired C source /
x86 assembly listing corpora.

Every operator is ``DataFrame -> DataFrame`` built from Spark SQL
expressions; see README.md for the operator map.
"""

__version__ = "0.1.0"
