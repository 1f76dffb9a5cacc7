"""parley: conversation data as Spark jobs.

Every public function takes and returns DataFrames (``operators``, ``streaming``,
``sources``) or Columns (``functions``).  Nothing here triggers a job unless its name
says so (sinks, streaming starters).
"""
