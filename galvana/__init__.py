"""galvana: battery-ageing analytics expressed as Spark DataFrame jobs."""
