"""PySpark-native analytics for collections of disclosure documents and access logs."""
