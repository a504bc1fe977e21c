"""``DataFrame -> DataFrame`` building blocks; lazy unless a docstring says otherwise."""
