"""claimscope: Spark-native analytics for insurance-claim fraud screening.

Every public function takes and returns DataFrames; nothing data-sized is
collected to the driver.  Sub-packages:

* ``sources``   - readers, writers and the mapping of the test tables onto claims
* ``functions`` - fixed value tables and column expressions
* ``operators`` - reports, windows, reshapes, graph, features, models, metrics
* ``plans``     - the registry of named queries and their SQL twins
* ``streaming`` - (empty by design, see its docstring)
"""

__version__ = "0.1.0"
