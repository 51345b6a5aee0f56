"""Network-traffic analytics on PySpark: sessions, visits, devices, enrichment and drill-downs as DataFrame operators."""
