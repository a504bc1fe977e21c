"""Freight accessorial-cost analytics as Spark DataFrame operators.

Layers, from the bottom up:

* ``functions``  column expressions (no DataFrame, no action)
* ``sources``    readers, writers and the table bundle
* ``operators``  ``DataFrame -> DataFrame`` building blocks
* ``plans``      the questions a freight team asks, composed from operators
"""

from haulscope.sources.tables import FreightTables
from haulscope.operators.filters import Selection

__all__ = ["FreightTables", "Selection"]
