"""The questions, composed from operators over the stored tables.

Every plan takes ``FreightTables`` and, where a page can be filtered, a ``Selection``.
"""
