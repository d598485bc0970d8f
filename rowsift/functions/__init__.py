"""Value semantics as Spark expressions."""
