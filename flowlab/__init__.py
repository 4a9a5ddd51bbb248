"""flowlab: network-flow analysis under domain shift, as PySpark DataFrame functions."""
