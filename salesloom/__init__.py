"""salesloom: sales-order, invoice and product analytics as Spark jobs.

Every job takes DataFrames and returns a lazy DataFrame built only from
built-in Spark operators; nothing is collected to the driver.
"""

__version__ = "0.1.0"
