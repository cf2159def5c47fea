"""glucoframe: Spark-native data work for continuous-glucose day profiles.

Every operator takes DataFrames and returns a DataFrame. Nothing is collected
to the driver; randomness is a stateless hash of keys (see
``glucoframe.functions.hashing``) so results do not depend on partitioning.
"""

__version__ = "0.1.0"
