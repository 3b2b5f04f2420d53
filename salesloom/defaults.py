"""Fixed values taken from the reference, used as parameter defaults.

Every one of them is only a default: the jobs take each as an argument.
"""

# Order status codes of the open-order and overdue reports.
OPEN_DELIVERY_STATUSES = ("A", "B")   # delivery status: not delivered, partly delivered
CLOSED_OVERALL_STATUS = "C"           # overall status: completed
NOT_DELIVERED_STATUS = "A"            # shown as "not delivered" in the digest

# Report sizes.
OPEN_ORDER_ROWS = 20
DELAYED_LINE_ROWS = 20
DUPLICATE_KEY_ROWS = 10
SAMPLE_ROWS = 30
DISTINCT_VALUE_ROWS = 20
PREVIEW_ROWS = 3

# Invoice filters of the monthly sales queries.
EXCLUDED_BILLING_TYPES = ("S1", "S2", "RE", "RK")
SALES_CURRENCY = "USD"

# Description language of the keyword searches.
TEXT_LANGUAGE = "E"
