"""sparkloom: catalog, document and workflow analytics written as Spark DataFrame jobs."""

__version__ = "0.1.0"
