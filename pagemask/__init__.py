"""pagemask: Spark jobs that find, check and carry over redactions in document collections."""
