"""Readers and writers: SLOW5 text, FASTQ, PAF."""
