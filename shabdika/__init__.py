"""Analytics over digitised documents, written as Spark DataFrame plans."""
