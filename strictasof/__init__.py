"""Point-in-time analytics on Spark.

Every public function takes DataFrames or Columns and returns DataFrames or Columns; nothing is
collected to the driver except sizes and small fitted parameters.
"""

__version__ = "0.1.0"
