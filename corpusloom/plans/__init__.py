"""The registered queries over the given tables, with the SQL that checks them."""
