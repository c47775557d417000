"""shirube: evidence-backed entity attributes on Spark.

Page and line tables go in; extracted values with provenance, entity matches, versioned
readings, changes, adoption decisions and flat output cells come out. Every public function
takes and returns DataFrames (or Columns) and stays lazy.
"""
import sys

from pyspark import cloudpickle

# Executors get the few Python helpers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
