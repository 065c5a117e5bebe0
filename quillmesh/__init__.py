"""quillmesh: PySpark-native analytics over collections of policy documents."""

__version__ = "0.1.0"
