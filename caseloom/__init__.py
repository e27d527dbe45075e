"""caseloom: a PySpark-native engine for e-mail evidence analytics.

Every operator is ``DataFrame -> DataFrame`` (or ``Column -> Column``), lazy unless
its docstring says that it iterates, and never changes the session's configuration.
"""
