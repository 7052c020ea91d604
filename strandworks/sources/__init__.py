"""Sources and sinks: reads, sequences, alignments, regions and tables."""
