"""The registered queries, each run over whole tables, and the SQL that checks them."""
