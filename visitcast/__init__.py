"""visitcast: daily demand forecasting features and domain transfer on Spark.

Sub-packages
------------
sources     table loading, fixture views over the driver tables, sinks
functions   column expressions (calendar facts, guarded log, kernel weights)
operators   reusable DataFrame operators (aggregate-and-join, kernel median,
            fused trailing windows, encoders, sampling, selection, alignment)
plans       end-to-end jobs (feature pipeline, train sets, learners, reports)
"""

__version__ = "0.1.0"
