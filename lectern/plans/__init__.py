"""Views on the driver tables and the registered queries."""
