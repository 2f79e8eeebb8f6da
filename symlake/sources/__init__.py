"""Sources and sinks: archives, directories, class files, logs, stored indexes, exports."""
