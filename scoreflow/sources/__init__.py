"""Sources and sinks: text tables, versioned tables, intake records, driver adapters."""
