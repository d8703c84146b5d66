"""Column-expression helpers; everything returns a ``Column`` and stays JVM-side."""
