"""Structured Streaming jobs for the append logs (feedback, spends).

Every job reads landed files with a file source (``maxFilesPerTrigger`` bounds
a micro-batch), keeps its checkpoint in the cluster's shared folder, and
writes through ``foreachBatch`` into one directory per batch id, overwritten
on retry, so a replayed batch never duplicates rows.
"""
