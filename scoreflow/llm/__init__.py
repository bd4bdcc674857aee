"""Operators for training-data pipelines; nothing else in the package imports this folder."""

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this folder.
import scoreflow.llm as _here

cloudpickle.register_pickle_by_value(_here)
