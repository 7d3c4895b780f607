"""Tables, files and fixed values that operators read."""
