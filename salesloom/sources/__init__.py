"""Sources and sinks: named tables, SQL text, the CSV extract, and views of
the test tables in the sales-order data model."""
