"""Sources and sinks: readers, archive members, dimension tables, writers."""
