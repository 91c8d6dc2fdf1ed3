"""Study rule tables, end-to-end preparation, and the registered queries."""
