"""Operators of a training-data pipeline: documents in, filtered, scored or encoded documents out.

All of them read ``documents``-like frames (``doc_id``, ``text`` and, where stated, ``lang`` and
``source``) by column name and ignore any other column.  A document is a (``doc_id``, ``text``)
pair: operators that gather rows of a document count exact repeats of a row once.
"""
