"""inkwell: a Spark-native engine for telling human-written from
machine-generated text at corpus scale.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst plans it and Spark partitions and shuffles it.
"""

__version__ = "0.1.0"
