"""Named queries over the supplied tables, each with the SQL that states it."""
