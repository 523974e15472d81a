"""What FROM can name."""
