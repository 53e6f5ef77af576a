"""Named queries over the sample tables, each with the SQL that it must agree with."""
