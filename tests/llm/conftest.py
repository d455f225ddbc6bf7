"""Results of steps go to the session's shared folder, or to a temporary one where it names none."""
