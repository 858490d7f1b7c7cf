"""Training-data operators: one module per operator, their queries in queries.py."""

import pyarrow as pa
from pyspark import TaskContext

if TaskContext.get() is not None:
    # Python workers live on between tasks: let Arrow give memory back to the system
    pa.set_memory_pool(pa.system_memory_pool())
