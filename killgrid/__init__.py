"""killgrid: mutation-testing analytics expressed as Spark DataFrame plans."""
