"""suitestat: analytics over HTTP API test suites as Spark plans."""
