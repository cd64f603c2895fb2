"""Name to query and name to DuckDB SQL, gathered from the query modules."""

from visagelake.plans import collection, faces

QUERIES = collection.QUERIES | faces.QUERIES
ORACLE = collection.ORACLE | faces.ORACLE
