"""No streaming operators: every input of this library is a set of files.

The quarantine cascade, the windowed event counts and the trailing review
count are plain ``DataFrame -> DataFrame`` transforms without actions, so a
``foreachBatch`` writer can call them on each micro-batch as they are.
"""
