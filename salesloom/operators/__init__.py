"""Jobs: version selection, order reports, keyword rules, monthly sales,
dashboard slices and catalog lookups."""
