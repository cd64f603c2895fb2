"""Tables from images and files, and their sinks."""
