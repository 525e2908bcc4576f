"""Survey sampling and event rates over ocean-profile candidates, as Spark DataFrame operators."""
