"""orelode: analytics over nested binary assets, on PySpark."""
