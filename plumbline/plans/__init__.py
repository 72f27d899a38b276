"""From a table to a report, requests, suggestions and a script."""
