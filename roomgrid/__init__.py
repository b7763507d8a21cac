"""roomgrid: listing search and message analytics as Spark DataFrame jobs.

Every operator is a function DataFrame(s) -> DataFrame.  Sub-packages:

* ``sources``    readers for the driver tables, the listing model views, nested JSON,
                 labelled CSV and message streams
* ``functions``  Column-expression helpers (text normalisation, vector math)
* ``operators``  search, load, integrity, dialogue, language, intent, history,
                 traces and rate limiting
* ``streaming``  Structured Streaming versions of the limiter and message routing
* ``plans``      the registered query catalogue and its SQL oracles
"""

__version__ = "0.1.0"
