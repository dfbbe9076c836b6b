"""evalspark: evaluation-result analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame(s), params -> DataFrame``
whose work runs on Spark (Catalyst plans, shuffles, windows, state).
Sub-packages:

* ``sources``   -- table readers, the input views, file sources and sinks
* ``functions`` -- column-expression builders (scalar functions)
* ``operators`` -- the operators of the inventory, grouped by area
* ``plans``     -- composed reports and the query catalog
* ``streaming`` -- Structured Streaming versions of the incremental operators
"""

__version__ = "0.1.0"
